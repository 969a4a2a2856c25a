"""Part of hushframe."""
