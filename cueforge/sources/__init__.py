"""Where cues, audio and voices come from, and where results go."""
