"""DataFrame-to-DataFrame operators over entity-by-period panels."""
