"""File streams into merged tables."""
