"""Readers and writers for manifests, images, label files and GeoJSON."""
