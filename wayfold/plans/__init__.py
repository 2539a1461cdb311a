"""Domain jobs: each is one lazy DataFrame plan."""
