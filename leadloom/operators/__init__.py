"""Table operators: analytics, leads, companies, duplicates, cards, exports."""
