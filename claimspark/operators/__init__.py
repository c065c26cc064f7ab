"""DataFrame-to-DataFrame operators over claims, pages, terms and predictions."""
