"""Tables, files and packages as inputs, and tables as outputs."""
