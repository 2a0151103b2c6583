"""Plans: selectors compiled to joins over a table of nodes."""
