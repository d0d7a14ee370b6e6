"""Scalar functions: text, stems, languages and vectors."""
