"""DataFrame-to-DataFrame operators; compose them with ``df.transform``."""
