"""Readers and writers of reviews, word sets, lexicons, tags and manifests."""
