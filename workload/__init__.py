"""The registered queries: test tables in, operator results out, with oracle SQL."""
