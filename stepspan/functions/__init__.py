"""Part of stepspan."""
