"""Running operators on streams, and the operators that need keyed state."""
