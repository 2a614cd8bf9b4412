"""Column -> Column functions: null/IEEE helpers, geodesy, moist thermodynamics."""
