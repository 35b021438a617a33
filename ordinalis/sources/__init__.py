"""Where tables live: files, options, manifests, importers and synthetic tables."""
