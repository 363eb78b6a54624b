"""Event tables and streams: epochs, sessions, scoring of arriving turns."""
