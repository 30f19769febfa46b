"""Inputs: tables, uploaded files, responses of card readers."""
