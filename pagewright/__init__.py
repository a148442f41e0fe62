"""Web-page assets as Spark relations: parsing, entity resolution, ranking, selection, palettes, fonts and scan streams."""
