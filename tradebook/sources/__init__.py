"""Tables on shared storage."""
