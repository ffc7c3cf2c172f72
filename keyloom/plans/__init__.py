"""What a program means before it runs: array metadata, key arithmetic, loop analysis and schedules."""
