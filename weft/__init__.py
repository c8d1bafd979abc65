"""weft: preparation and diversity analytics of line-aligned bilingual text on Spark."""
