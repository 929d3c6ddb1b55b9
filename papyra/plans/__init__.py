"""The query catalogue and the table bindings it runs on."""
