"""Small functions that operators share."""
