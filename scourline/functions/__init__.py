"""Pure Column -> Column expressions shared by all operators."""
