"""Readers: cursor-paged record source, artifact stores."""
