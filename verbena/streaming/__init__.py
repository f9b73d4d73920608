"""Streams of the same relations; an extension, since the relations themselves need none."""
