"""Reports over artifacts and the registered queries."""
