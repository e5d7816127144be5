"""Column functions: text, paths, hashes, geometry, vectors, script blocks and audio samples."""
