"""DataFrame operators that turn captured news, listings and filings into reviewable leads."""
