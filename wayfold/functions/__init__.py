"""Column expressions: text, addresses, contacts, dates and places. No Python UDFs."""
