"""Pure functions from columns to columns."""
