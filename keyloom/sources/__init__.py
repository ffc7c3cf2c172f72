"""Where arrays come from: text, tables and generated cells."""
