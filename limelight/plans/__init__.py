"""Plan shapes shared by operators, and the jobs that string operators together."""
