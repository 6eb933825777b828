"""Record types and scalar expressions."""
