"""DataFrame operators; each works alone on any DataFrame."""
