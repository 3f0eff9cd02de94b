"""The same work on streams: quotas, duplicate requests, growing corpora, breakers and history caps."""
