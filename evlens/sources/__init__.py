"""Readers (canonical event view, date-sharded scans) and the partitioned writer."""
