"""The public operations, composed from the operators."""
