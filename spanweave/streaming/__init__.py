"""Documents that change while they are watched."""
