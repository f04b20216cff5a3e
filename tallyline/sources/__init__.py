"""Topics as tables or broker subscriptions, record schemas, data generators."""
