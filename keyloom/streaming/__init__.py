"""Write buffers fed by a stream."""
