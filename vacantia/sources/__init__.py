"""Sources: raw payloads to messages, postings and normalised jobs."""
