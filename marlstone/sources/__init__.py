"""Tables, imports and exports."""
