"""Image- and text-dataset curation operators, DataFrame in, DataFrame out."""
