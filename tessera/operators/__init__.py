"""Operators beyond SQL text: graphs, vectors, boxes, keys of JSON documents."""
