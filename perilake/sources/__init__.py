"""Reading and writing files, tables and model artefacts."""
