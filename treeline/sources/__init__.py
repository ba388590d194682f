"""Sources: file trees, their contents, bundles and run logs."""
