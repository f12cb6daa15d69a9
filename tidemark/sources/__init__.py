"""Change-log, chunk and large-object sources, binary formats and generators."""
