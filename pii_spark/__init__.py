"""Find, mask and restore personal data in tables of text; prepare and measure detector data."""
