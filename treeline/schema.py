"""Schemas of the tables that the engine passes around."""

MANIFEST = (
    "path string, kind string, size bigint, mtime timestamp, mode int, readonly boolean, "
    "link_target string, real_path string, root string"
)
RESULTS = "path string, action string, ok boolean, bytes bigint, error string, seconds double"

MIB = 1 << 20
