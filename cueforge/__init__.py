"""A Spark engine for timed text: subtitles to aligned, rendered timelines."""
