"""Plan shapes shared by the operators: all of them keep every group splittable over many tasks."""
