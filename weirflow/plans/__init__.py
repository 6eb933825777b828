"""Task graphs, their runs, and the tools to look into them."""
