"""Row and set operators of the mapping model (projection, joins, dedupe, quality, ...)."""
