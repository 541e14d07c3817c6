"""Reading: landed workbook cells, and the bundled star-schema tables bound to the library's tables."""
