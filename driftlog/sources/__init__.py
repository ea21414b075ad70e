"""Where rows come from and go to: logs of events, topics, catalogs."""
