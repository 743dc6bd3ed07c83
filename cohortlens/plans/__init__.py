"""The two reports: programme overviews and learner progress."""
