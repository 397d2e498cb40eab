"""Plan-time checks: data models, paths and schema algebra, all without a session."""
