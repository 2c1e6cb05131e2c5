"""DataFrame -> DataFrame operators over mask, tile, score and box tables."""
