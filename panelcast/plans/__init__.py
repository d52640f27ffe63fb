"""The whole job and the registered queries."""
