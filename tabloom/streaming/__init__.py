"""tabloom streaming."""
