"""Reading and writing recordings, sessions, logs, encodings and templates."""
