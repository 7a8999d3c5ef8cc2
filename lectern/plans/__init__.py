"""Plan helpers shared by the operators: scratch tables and graph iteration."""
