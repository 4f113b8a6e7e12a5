"""Tables, views and file formats."""
