"""Report plans: the user-level questions, dispatch, dashboard and sinks."""
