"""Views of the test tables as flows and zones, the registered queries and their SQL."""
