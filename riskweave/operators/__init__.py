"""The analytics operators."""
