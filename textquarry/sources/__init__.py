"""Storage: versioned tables of pages, segments and merge checkpoints."""
