"""talentlake."""
