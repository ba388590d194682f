"""Transfer plans and the verbs built from them."""
