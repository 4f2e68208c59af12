"""DataFrame operators: postings, search, merge, live versions, heavy keys."""
