"""Page intake and pluggable providers."""
