"""Record jobs fed by a stream."""
