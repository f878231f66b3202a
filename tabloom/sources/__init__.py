"""tabloom sources."""
