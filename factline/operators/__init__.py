"""Generic DataFrame operators used by every job."""
