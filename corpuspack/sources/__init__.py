"""Where files come from: directory trees, remote listings, ignore files, references."""
