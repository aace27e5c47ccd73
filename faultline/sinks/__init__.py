"""Writers for reports, audit entries and outbox rows."""
