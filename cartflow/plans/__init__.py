"""Plans built from the operators: the retail view of a sales schema, layer builds, registered queries."""
