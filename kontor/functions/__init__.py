"""Column-level building blocks (Column -> Column, or staged DataFrame projections)."""
