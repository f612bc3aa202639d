"""functions layer of the session-history engine."""
