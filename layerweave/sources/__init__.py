"""Readers and writers: delimited text, fixed-width text, tables, HTML, graph exports."""
