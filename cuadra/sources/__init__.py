"""Statement readers: tables, XML and PDF text to the two relations."""
